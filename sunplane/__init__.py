"""sunplane: a Spark-native engine for solar-panel geometry from point clouds."""
