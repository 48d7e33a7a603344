"""Reading and writing logs and labelled datasets."""
