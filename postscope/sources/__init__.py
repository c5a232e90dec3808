"""Reading and writing posts and vectors."""
