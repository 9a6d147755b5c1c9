"""Copy tables between stores, normalise them on the way, and prove the copy is right."""
