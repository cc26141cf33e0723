"""Plans: which shards are read, in what order, by whom, and how a configuration becomes operators."""
