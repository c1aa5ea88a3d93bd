"""knnloom: all-k-nearest-neighbour joins over 2-D points as lazy Spark plans."""
