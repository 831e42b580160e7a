from .detection import Detected, detect, detect_run
from .mining import found_by_search, mine, mine_basic, mine_from_search, mine_run, score_and_rank
from .validation import Validated, validate, validate_run

__all__ = ["Detected", "Validated", "detect", "detect_run", "found_by_search", "mine", "mine_basic",
           "mine_from_search", "mine_run", "score_and_rank", "validate", "validate_run"]
