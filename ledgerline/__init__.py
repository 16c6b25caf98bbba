"""Order-book data jobs on Spark: recorded exchange feeds to exact, checked books, and figures on them."""
