"""Default settings, as rows a settings overlay can join to."""

from __future__ import annotations

# Section -> key -> default, text form. None is an explicit null.
DEFAULT_SETTINGS = {
    "project": {
        "name": "",
        "version": "0.1.0",
        "description": "",
        "author": "",
        "email": "",
        "url": "",
    },
    "release": {"branch": "main", "tag_prefix": "v", "changelog": "CHANGELOG.md"},
    "build": {"clean": "true", "test": "true", "docs": "true"},
    "publish": {"repository": "pypi", "skip_existing": "false"},
    "ai": {"model": "gpt-4", "api_key": None},
    "github": {"org": None, "repo": None, "private": "false"},
    "quality": {"max_complexity": "15", "max_duplicates": "1.0"},
}

SECTIONS = tuple(DEFAULT_SETTINGS)

START_VERSION = DEFAULT_SETTINGS["project"]["version"]
MAX_COMPLEXITY = int(DEFAULT_SETTINGS["quality"]["max_complexity"])
MAX_DUPLICATES = float(DEFAULT_SETTINGS["quality"]["max_duplicates"])

# Shortest accepted text and lines per clone window.
MIN_TEXT_LENGTH = 50
CLONE_LINES = 6

# Fields every manifest needs, sections every description needs.
REQUIRED_FIELDS = ("name", "version", "description", "readme")
REQUIRED_SECTIONS = ("Installation", "Usage")

# Published complexity ranks, lowest metric of each.
BANDS = {"A": 1, "B": 6, "C": 11, "D": 21, "E": 31, "F": 41}
