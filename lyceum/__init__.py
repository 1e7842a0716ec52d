"""Academic analytics on Spark: cleaning, GPA, star-schema loads, rankings, risk and attendance."""
