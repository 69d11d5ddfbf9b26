"""Functions of the strict dialect as Column expressions: no Python runs on executors."""

from .strict import FUNCTIONS, divide, modulo, seeded_random

__all__ = ["FUNCTIONS", "divide", "modulo", "seeded_random"]
