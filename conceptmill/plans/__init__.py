"""Named queries over the engine's operators."""
