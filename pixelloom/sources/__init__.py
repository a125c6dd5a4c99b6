"""Where pixel tables come from and where they go."""
