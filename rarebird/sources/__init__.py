"""Reading and writing tables, models and scaler statistics; driver-table fixtures."""
