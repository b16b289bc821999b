"""Search requests, their predicates, and the plans made of them."""
