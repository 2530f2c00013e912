"""Join and window plans that the operators share."""
