"""Readers and the mapping from the star-schema tables to the analysis inputs."""
