"""Jobs that run from the command line over tables in folders."""
