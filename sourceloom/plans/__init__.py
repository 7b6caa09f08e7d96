"""Query shapes of the analysed SQL, as Spark SQL over the star-schema tables."""
