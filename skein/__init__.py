"""skein: sequence, assembly-graph and corpus operators as Spark DataFrame jobs."""
