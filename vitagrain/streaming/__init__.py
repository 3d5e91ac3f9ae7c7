"""The only stream-shaped work is appending activity facts as they arrive."""
