"""Statistical models: each pass over the rows is one distributed fold to a small vector; the algebra on it runs on the driver."""
