"""Errors of parameters and of signals."""


class SignalError(Exception):
    """Base of all errors here."""


class SignalValueError(SignalError, ValueError):
    """A parameter or a signal that an operator can't take."""


def positive_int(value, name: str) -> int:
    if isinstance(value, bool) or int(value) != value or value < 1:
        raise SignalValueError(f"{name} must be a positive integer")
    return int(value)


def non_negative(value, name: str) -> float:
    out = float(value)
    if not out >= 0 or out == float("inf"):
        raise SignalValueError(f"{name} must be finite and not negative")
    return out


def odd_window(value, name: str = "window_size") -> int:
    if positive_int(value, name) % 2 == 0:
        raise SignalValueError(f"{name} must be odd")
    return int(value)
