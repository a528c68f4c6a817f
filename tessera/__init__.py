"""Code-facts analytics and data-processing kernels on Spark."""
