"""Column expressions: dates, text, similarity, vectors. All built-in, none leaves the JVM."""
