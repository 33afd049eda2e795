"""Schemas and constants of the tables this engine works on."""

from __future__ import annotations

# Reason bits of a change record.
R_OVERWRITE, R_EXTEND, R_TRUNCATE = 0x1, 0x2, 0x4
R_CREATE, R_DELETE, R_OLD_NAME, R_NEW_NAME = 0x100, 0x200, 0x1000, 0x2000
R_HARD_LINK, R_CLOSE = 0x10000, 0x80000000

# Attribute bits of a record.
A_DIRECTORY, A_REPARSE = 0x10, 0x400

# Flag bits of an entry, and the parents that stand for none.
F_DIR, F_REPARSE, F_ORPHAN, F_DEAD, F_TRUNCATED, F_SIZED = 1, 2, 4, 8, 16, 32
NO_PARENT = 4294967294
ROOT_FRN = 5
MAX_CLUSTERS = 0xFFFFFFFF
MAX_WALK = 4096

RECORDS = "ord long, frn long, parent_frn long, name string, attributes int"
SIZES = "frn long, clusters long, truncated boolean"
JOURNAL = "usn long, frn long, parent_frn long, reason long, name string, attributes int"
