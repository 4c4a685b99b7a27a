"""Where the library's tables come from."""
