"""Writers: flat and star loads, mbox, discovery, JSON, DOT, term index, tallies, lists."""
