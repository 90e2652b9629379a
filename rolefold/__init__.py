"""Analytics over n-ary, role-labelled, bitemporal facts on Spark."""
