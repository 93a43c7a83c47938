"""Network-traffic analytics and flood detection as DataFrame-to-DataFrame Spark operators."""
