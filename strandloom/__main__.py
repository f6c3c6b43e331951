import sys

from strandloom.plans.cli import main

sys.exit(main())
