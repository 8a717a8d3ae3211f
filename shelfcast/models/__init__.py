"""MLlib training, selection, storage and scoring."""
