import sys

from quarrygraph.cli import main

sys.exit(main())
