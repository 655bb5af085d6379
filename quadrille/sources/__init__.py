"""Where items, cells, regions and texts come from, and where indexes and statistics go."""
