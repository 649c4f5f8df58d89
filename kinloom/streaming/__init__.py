"""Insert-then-query over ordered streams."""
