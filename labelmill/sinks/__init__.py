"""Writers for the CSV, JSONL and JSON layouts the readers take back."""
