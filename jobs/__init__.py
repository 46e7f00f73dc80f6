"""Jobs that run the library on tables: a command line and a configuration file each, the work in run()."""
