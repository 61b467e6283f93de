"""Relational operators on splat tables: filters, density, neighbours, order, codebooks, profiles."""
