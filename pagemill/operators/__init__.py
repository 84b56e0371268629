"""DataFrame transforms; each is lazy and collects nothing."""
