"""``python -m rulescope report ...`` (see :mod:`rulescope.report`)."""

from rulescope.report import main

main()
