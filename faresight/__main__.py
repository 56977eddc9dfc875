import sys

from faresight.cli import main

sys.exit(main())
