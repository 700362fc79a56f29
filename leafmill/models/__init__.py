"""Model calls: a protocol, a deterministic stand-in, and columns that call them."""
