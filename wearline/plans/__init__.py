"""Dataflows composed of operators: what a user of the engine asks for."""
