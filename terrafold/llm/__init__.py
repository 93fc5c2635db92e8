"""Operators that prepare training data for language and vision-language models. Nothing outside imports this package."""
