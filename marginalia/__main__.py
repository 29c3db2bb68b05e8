import sys

from marginalia.commands import main

sys.exit(main())
