"""Column functions: text cleaning, hashing, n-grams and string similarities."""
