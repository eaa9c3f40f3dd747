"""Column-level building blocks: text, stemming, scoring, snippets, salting."""
