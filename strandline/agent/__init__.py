"""What makes trajectories: tools, model clients and the loops that use them, all with the model as a plain function."""
