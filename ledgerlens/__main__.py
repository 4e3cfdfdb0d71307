import sys

from ledgerlens.cli import main

sys.exit(main())
