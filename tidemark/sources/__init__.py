"""Where change sets, history and targets are kept, and how they are exchanged."""
