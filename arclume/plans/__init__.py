"""Query front-ends and their plans."""
