import sys

from polyfold.cli import main

sys.exit(main())
