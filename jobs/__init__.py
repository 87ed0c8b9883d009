"""Jobs that users of the library run: each has a command line, a config file and a function that takes a session."""
