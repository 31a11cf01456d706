"""Named queries over the adapter views, each with its SQL twin."""
