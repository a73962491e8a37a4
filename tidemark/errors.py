"""What can go wrong, as one family of exceptions."""

from __future__ import annotations


class StorageError(Exception):
    """Base of all errors of the store."""

    prefix = ""

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.prefix}: {detail}" if detail and self.prefix else self.prefix or detail)


def _kind(name: str, prefix: str) -> type[StorageError]:
    return type(name, (StorageError,), {"prefix": prefix, "__module__": __name__})


# The message that each kind starts with.
Io = _kind("Io", "IO error")
Corruption = _kind("Corruption", "Corrupted data")
CorruptedData = _kind("CorruptedData", "Corrupted data")
InvalidFormat = _kind("InvalidFormat", "Invalid format")
NotFound = _kind("NotFound", "Resource not found")
KeyNotFound = _kind("KeyNotFound", "Key not found")
ChannelSend = _kind("ChannelSend", "Channel send error")
SystemTime = _kind("SystemTime", "System time error")
ConnectionFailed = _kind("ConnectionFailed", "Connection failed")
ConnectionClosed = _kind("ConnectionClosed", "Connection closed unexpectedly")
Timeout = _kind("Timeout", "Operation timeout")
LeaderError = _kind("LeaderError", "Leader error")
UnexpectedResponse = _kind("UnexpectedResponse", "Unexpected response from leader")
SyncFailed = _kind("SyncFailed", "Sync failed")
# not a kind of the fixed list: two writers met
Conflict = _kind("Conflict", "Conflict")
