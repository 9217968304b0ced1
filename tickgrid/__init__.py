"""tickgrid: Spark DataFrame operators over entities that move on a grid and change over time."""
