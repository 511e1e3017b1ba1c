"""Ready-made queries over the star schema, events, documents and a toy language."""
