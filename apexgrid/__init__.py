"""Race-season analytics and fantasy-game decisions as Spark jobs."""
