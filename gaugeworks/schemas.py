"""Names and numbers of record enums. Levels are ordinal."""

from __future__ import annotations

# Names and numbers of the record enums.
LEVELS = {"LEVEL_UNSPECIFIED": 0, "LEVEL_NOTE": 10, "LEVEL_FMT": 20, "LEVEL_LOW": 30, "LEVEL_MEDIUM": 40, "LEVEL_HIGH": 50}
NOTE, FMT, LOW, MEDIUM, HIGH = 10, 20, 30, 40, 50
SECURITY_CATEGORIES = ("CATEGORY_VULNERABILITY", "CATEGORY_SECRET", "CATEGORY_DEPENDENCY_ALERT")
