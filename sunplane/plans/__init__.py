"""Plans that join several operators, and what running them on a cluster needs."""
