"""Sources: the site registry, page URLs and captures, snapshot files."""
