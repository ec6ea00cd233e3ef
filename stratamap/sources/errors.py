"""Typed failures of reading an extract. Spark passes their class name and text on to the driver."""

from __future__ import annotations


class ExtractError(Exception):
    """Anything wrong with an extract."""


class UnexpectedEof(ExtractError):
    """The file ends inside a header or body."""


class InvalidHeaderSize(ExtractError):
    """The length before a header is cut off or unusable."""


class HeaderTooBig(ExtractError):
    def __init__(self, size: int):
        super().__init__(f"HeaderTooBig: a blob header of {size} bytes; the limit is {(1 << 16) - 1}")
        self.size = size


class MessageTooBig(ExtractError):
    def __init__(self, size: int):
        super().__init__(f"MessageTooBig: a message of {size} bytes; it must stay under {1 << 25}")
        self.size = size


class EmptyBlob(ExtractError):
    def __init__(self):
        super().__init__("EmptyBlob: no raw or zlib payload")


class BadMessage(ExtractError):
    """Bytes that are no message of the expected type."""

    def __init__(self, location: str, reason: str):
        super().__init__(f"BadMessage in {location}: {reason}")
        self.location = location


class StringIndexOutOfBounds(ExtractError):
    def __init__(self, index: int):
        super().__init__(f"StringIndexOutOfBounds: {index}")
        self.index = index


class StringNotUtf8(ExtractError):
    def __init__(self, index: int):
        super().__init__(f"StringNotUtf8: {index}")
        self.index = index
