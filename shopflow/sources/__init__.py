"""Input tables: schemas, loaders, test fixtures and materialisation."""
