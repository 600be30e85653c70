"""Named, parameterised analyses over the test tables, and plan checks."""
