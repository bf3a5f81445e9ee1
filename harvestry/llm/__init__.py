"""Training-data operators: ten DataFrame jobs over documents and conversations."""
