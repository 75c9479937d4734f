"""What is composed from them: requests, intake, store, request log."""
