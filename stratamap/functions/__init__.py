"""Column helpers on decoded elements."""

from stratamap.functions.elements import changeset, decimicro, degrees, deleted, has_tag, info_timestamp, tag, with_coordinates

__all__ = ["changeset", "decimicro", "degrees", "deleted", "has_tag", "info_timestamp", "tag", "with_coordinates"]
