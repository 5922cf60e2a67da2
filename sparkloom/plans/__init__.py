"""Tokenizer configurations and the execution plan that follows from them."""
