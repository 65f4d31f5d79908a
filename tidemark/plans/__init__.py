"""The engine's stages in one call."""
