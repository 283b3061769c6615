"""Where boxes and points come from and go to: DataFrames, and packed index buffers."""
