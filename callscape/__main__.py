import sys

from callscape.plans.commands import main

sys.exit(main())
