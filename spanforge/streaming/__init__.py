"""Incremental forms of operators over folders that files keep arriving in.  The engine's sources are
finite files; this is an extension for new files of the same kind."""
