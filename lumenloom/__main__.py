import sys

from lumenloom.cli import main

sys.exit(main(sys.argv[1:]))
