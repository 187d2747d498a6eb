"""Records as a stream. Normalization and keys are stateless column expressions, so they run on a streaming DataFrame as they are."""
