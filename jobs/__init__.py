"""Jobs that users run on their tables: each a function of a session and plain paths, and a command line around it."""
