"""Operators: meshes, finite elements, state-space recursions, EM, inference, prediction."""
