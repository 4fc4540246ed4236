"""Signal library: labels for every bar of every code.

``signal_frame(bars, names, di)`` returns (code, ts, one label column per signal). Label texts are
fixed values: downstream scoring looks them up.
"""

from barloom.operators.signals import bar, jcc, pos, sta, tas, vol  # noqa: F401
from barloom.operators.signals.base import NONE, SIGNALS, signal_frame, signal_rows  # noqa: F401
