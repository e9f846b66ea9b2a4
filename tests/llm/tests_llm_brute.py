from test_decontaminate import brute as contaminated
from test_simhash import brute_keepers as keepers

__all__ = ["contaminated", "keepers"]
