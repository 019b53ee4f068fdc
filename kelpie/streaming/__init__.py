"""Incremental runs over growing vector tables (an extension: the batch queries need none of it)."""
