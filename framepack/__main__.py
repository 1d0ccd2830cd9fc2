from framepack.cli import main

main()
