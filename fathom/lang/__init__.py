"""The query language: lexer, parser, and the binding of variables and fragments."""
