"""Parameters and fixed value tables shared by all operators."""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Params:
    """Query parameters; every operator takes them as keyword defaults."""

    lineup_budget: float = 100.0
    transfer_threshold: float = 10.0
    transfer_penalty: float = 10.0
    free_transfers: int = 2
    price_sensitivity: float = 1.0
    new_entrant_position: float = 18.0
    half_life: float = 10.0
    n_scenarios: int = 500
    min_train: int = 5
    n_drivers: int = 5
    n_constructors: int = 2


DEFAULTS = Params()

# Fixed values of the game rules (position -> points).
RACE_POINTS = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}
SPRINT_POINTS = {1: 8, 2: 7, 3: 6, 4: 5, 5: 4, 6: 3, 7: 2, 8: 1}
QUALI_POINTS = {1: 10, 2: 9, 3: 8, 4: 7, 5: 6, 6: 5, 7: 4, 8: 3, 9: 2, 10: 1}
DNF_POINTS = -20
DSQ_POINTS = -20
QUALI_NO_TIME_POINTS = -5
SPRINT_QUALI_NO_TIME_POINTS = -10
FASTEST_LAP_POINTS = 10
# Fixed values: (cars in Q3, cars in Q2 only) -> constructor bonus; any other key -1.
Q_PROGRESSION = {(2, 0): 10, (1, 1): 5, (1, 0): 5, (0, 2): 3, (0, 1): 1, (0, 0): -1}
Q_PROGRESSION_OTHER = -1

# Fixed values of the price rules.
BANDS = (("great", 1.2), ("good", 0.9), ("poor", 0.6))  # strictly above; else terrible
TIER_A_FROM = Decimal("19.0")
PRICE_CHANGE = {
    ("great", "A"): Decimal("0.3"), ("good", "A"): Decimal("0.1"),
    ("poor", "A"): Decimal("-0.1"), ("terrible", "A"): Decimal("-0.3"),
    ("great", "B"): Decimal("0.6"), ("good", "B"): Decimal("0.2"),
    ("poor", "B"): Decimal("-0.2"), ("terrible", "B"): Decimal("-0.6"),
}
PRICE_FLOOR, PRICE_CEILING = Decimal("3.0"), Decimal("34.0")
CARRY_FLOOR, CARRY_CEILING = Decimal("5.0"), Decimal("28.0")
DEFAULT_DRIVER_PRICE, DEFAULT_TEAM_PRICE = Decimal("10.0"), Decimal("15.0")

PRACTICE = ("FP1", "FP2", "FP3")

# Schedule session labels -> session codes.
SESSION_CODES = {
    "Practice 1": "FP1", "Practice 2": "FP2", "Practice 3": "FP3",
    "Qualifying": "Q", "Sprint Qualifying": "SQ", "Sprint Shootout": "SQ",
    "Sprint": "S", "Race": "R",
}
