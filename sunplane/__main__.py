import sys

from sunplane.cli import main

sys.exit(main())
