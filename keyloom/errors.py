"""Error codes of the engine and the exception that carries them."""

from __future__ import annotations

from enum import IntEnum


class ErrorCode(IntEnum):
    # fixed values: the codes clients know
    OK = 0x00
    SYSTEM_UNKNOWN = 0x01
    SYSTEM_UNKNOWN_PROTOCOL_VERSION = 0x02
    SYSTEM_OUT_OF_SPACE = 0x03
    SYSTEM_OUT_OF_MEMORY = 0x04
    SYSTEM_DISK_ERROR = 0x05
    SYSTEM_CORRUPTED_FILE = 0x06
    CONNECTION_CLOSED = 0x10
    CONNECTION_NOT_EXIST = 0x11
    PROTOCOL_BAD_MESSAGE_FORMAT = 0x20
    PROTOCOL_BAD_MESSAGE_LENGTH = 0x21
    PROTOCOL_BAD_OPCODE = 0x22
    PROTOCOL_BAD_PREPARED_ID = 0x23
    PROTOCOL_BAD_PREPARED_VALUE = 0x24
    SQL_UNKNOWN_ENTITY = 0x30
    SQL_WRONG_VALUE_FORMAT = 0x31
    SQL_SYNTAX_ERROR = 0x32
    SQL_DDL_ERROR = 0x33
    SQL_UNKNOWN_DATA_TYPE = 0x34
    SQL_NOT_FOUND = 0x35
    SQL_UNSUPPORTED = 0x36


class EngineError(Exception):
    def __init__(self, code: ErrorCode, message: str) -> None:
        super().__init__(message)
        self.code = code


def syntax(message: str) -> EngineError:
    return EngineError(ErrorCode.SQL_SYNTAX_ERROR, message)


def unsupported(message: str) -> EngineError:
    return EngineError(ErrorCode.SQL_UNSUPPORTED, message)


def ddl(message: str) -> EngineError:
    return EngineError(ErrorCode.SQL_DDL_ERROR, message)


def unknown(message: str) -> EngineError:
    return EngineError(ErrorCode.SQL_UNKNOWN_ENTITY, message)


def bad_value(message: str) -> EngineError:
    return EngineError(ErrorCode.SQL_WRONG_VALUE_FORMAT, message)
