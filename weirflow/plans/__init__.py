"""Rules, profiles and whole flows."""
